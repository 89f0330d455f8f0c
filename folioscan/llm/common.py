"""Shared helpers of the training-data operators: tables, scratch space, vectorised word hashes.

Texts are split into words on the six ASCII white-space bytes (space, \\t .. \\r), which is safe on
UTF-8, so all hashing runs on byte arrays in numpy, block by block, whatever a text's length.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes hashed at once; bounds the working memory of a Python worker.
BLOCK_BYTES = 1 << 20
#: Bytes of a text hashed in one step.
HASH_BYTES = 1 << 16
#: The setting by which a query's shuffle files are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD = r"[^\x20\x09-\x0D]+"

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own if unset and all is on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="folioscan-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Folders made while a sweep() is open.
_SCRATCH: list[list[str]] = []


def scratch(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/folioscan-{uuid.uuid4().hex[:12]}-{label}"
    for made in _SCRATCH:
        made.append(path)
    return path


def roots(df: DataFrame) -> list[str]:
    """The folders that the plan of df reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = []
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths()
            found += [paths.apply(i).toString() for i in range(paths.size())]
    return found


def remove(spark: SparkSession, made: list[str], kept: list[str]) -> list[str]:
    """Removes the scratch folders made, but for those among kept, which are returned."""
    names = {path.rstrip("/").rpartition("/")[2] for path in kept}
    left = [path for path in made if path.rpartition("/")[2] in names]
    for path in made:
        if path not in left:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return left


@contextlib.contextmanager
def sweep(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes the scratch folders that were made inside, but for that of the table given to the function it yields."""
    made, kept = [], []
    _SCRATCH.append(made)
    try:
        yield lambda df: kept.extend(roots(df)) or df
    finally:
        _SCRATCH[:] = [m for m in _SCRATCH if m is not made]
        remove(spark, made, kept)


@contextlib.contextmanager
def gathered(made: list[str]) -> Iterator[None]:
    """Adds the scratch folders that are made inside to made."""
    _SCRATCH.append(made)
    try:
        yield
    finally:
        _SCRATCH[:] = [m for m in _SCRATCH if m is not made]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """df written to a table in the shared folder and read back: lineage is cut, a lost executor costs nothing. The shuffle files of the write go with its end."""
    spark = df.sparkSession
    path = scratch(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """True for the test fold: crc32 of the id as text, mod 5, is 0. False where the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unmix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n at least."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _POWERS = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, np.uint64(b))], dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _POWERS


def lower_bytes(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased, nothing else changed; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order: a polynomial of its bytes, as a difference of the block's running sums."""
    out = []
    at = 0
    while at < len(data):
        end = min(len(data), at + HASH_BYTES)
        while end < len(data) and not _IS_SPACE[data[end]]:
            end += 1  # blocks end between words
        a = np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)
        space = np.empty(len(a) + 2, dtype=bool)
        space[0] = space[-1] = True
        np.take(_IS_SPACE, a, out=space[1:-1], mode="clip")
        edge = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = edge[::2], edge[1::2]
        if len(starts):
            power, inverse = _powers(len(a))
            sums = np.empty(len(a) + 1, dtype=np.uint64)
            sums[0] = 0
            terms = a.astype(np.uint64)
            terms += np.uint64(1)
            terms *= power[: len(a)]
            np.cumsum(terms, out=sums[1:])
            own = (sums[ends] - sums[starts]) * inverse[starts]
            out.append(mix64(own + (ends - starts).astype(np.uint64)))
        at = end
    if len(out) == 1:
        return out[0]
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; the whole sequence if it has fewer; nothing without words."""
    if not len(words):
        return words
    width = min(n, len(words))
    count = len(words) - width + 1
    total = np.full(count, np.uint64(width))
    for k in range(width):
        total += words[k : k + count] * np.uint64(2 * k * 0x632BE59BD9B4E019 + 1 & (1 << 64) - 1)
    return mix64(total)


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, component): the smallest id reachable, for every id in an edge.

    Labels fall to the smallest neighbour's label and then to their label's label, until nothing changes;
    each round is written to the shared folder, and only a count comes to the driver.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component"))
    labels = materialise(labels, "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        fell = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = fell.select(F.col("node").alias("parent"), F.col("component").alias("jump"))
        step = fell.join(up, F.col("component") == F.col("parent")).select("node", "was", F.least("component", "jump").alias("component"))
        step = materialise(step, "labels")
        labels = step.select("node", "component")
        if step.where("was <> component").isEmpty():
            return labels


def batches_of_texts(texts: list, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `most` characters together (one row at least)."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def text_slices(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of runs of rows of an Arrow column whose texts have about `most` bytes together (one row at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield start, column.slice(start, end - start).to_pylist()
        start = end


def tidy(work: Callable) -> Callable:
    """work for mapInArrow that gives the memory it has freed back to the system when a task ends, for Python workers live on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


_SHARED: list = []


def share(spark: SparkSession, value):
    """value broadcast, until let_go()."""
    _SHARED.append(spark.sparkContext.broadcast(value))
    return _SHARED[-1]


def let_go() -> None:
    """The executors' copies of what share() has sent so far are removed; a plan that still needs one gets it again."""
    while _SHARED:
        _SHARED.pop().unpersist()


def unused(columns: list[str], name: str) -> str:
    """name, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def own(columns: list[str]) -> list[Column]:
    """The columns of these names, whatever signs they hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def filtered(docs: DataFrame, work: Callable, text: str = "text") -> DataFrame:
    """docs.mapInArrow(work, own schema), whatever signs the names hold; work finds the text in the column `text`, other columns under their numbers."""
    names = [text if c == text else str(k) for k, c in enumerate(docs.columns)]
    plain = docs.select(*(c.alias(n) for c, n in zip(own(docs.columns), names, strict=True)))
    return plain.mapInArrow(tidy(work), plain.schema).toDF(*docs.columns)
