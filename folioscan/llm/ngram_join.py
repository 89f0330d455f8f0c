"""N-gram Jaccard join by multiple-global-order prefix filtering.

Two documents link when their sets of distinct 5-word shingles have a Jaccard similarity of 0.75 or more.
Then, under any total order of all shingles, the first n - ceil(0.75 n) + 1 shingles of both sets (their
prefixes) share one. The orders used here put shingles by a band of how common they are (rare first) and,
inside a band, by a hash seeded with the order's number, so that each order has another prefix. A pair is
a candidate only if its prefixes meet under every order; then the sets are compared exactly.

Steps, each written to the shared folder:

1. Count all shingles into a sketch, one counter for about four shingles, 2^25 counters at most (a
   parameter; any error in it only makes an order less good, never wrong). Its bands, a byte each, are broadcast.
2. Each task collapses equal sets to one representative and sends each prefix shingle of the first order
   once, dealt by shingle hash; a shingle that the sketch calls hot is dealt to several salts. Spark sorts what a
   task receives by shingle and by the shingle's place in its document, nearest to the front first. The first
   document is the shingle's leader; shingles under which no two documents can link are left out.
3. Pairs (leader, document) that pass the length and position filter (and the best leader of a hot shingle with those of
   its other salts) are candidates. Connected components over those that link.
4. What may still join two components: pairs under a shared prefix shingle whose documents lie in
   different components. Documents outside a shingle's largest component meet the others, by classes of length
   and, where they are many, cell by cell of a grid; pairs inside one component are never formed. Then as in 3.

The length and position filter: if x and y, with n_x and n_y shingles, share their first shingle at places p_x and p_y, they
can link only if n_y <= most_x and n_x <= most_y, most_x = (1.75 / 0.75) (n_x - p_x) - n_x. So the shorter one must
have most >= n ("wide"), its place within the first seventh. Documents that share a passage too short for a
link have unlike, rarer shingles before it, are not wide under the passage's shingles, and form no pairs.

Candidates are first held against the other orders: a document's prefixes there, as 32-bit hashes, travel to its
pairs; texts follow only for pairs whose prefixes meet under every order. To compare g documents with one leader,
the leader is copied once for each `partners` of them.

So a group of g copies or near copies costs about g tests and not g * g / 2, and no link between
components is lost: every pair that shares a prefix shingle is in one component or has been tested.

Defined cases: null or empty text, or white space only: no shingles, linked with nothing, its own
component. Repeated ids are one document to the links (its texts are held in memory together), and each row is returned. A null id gives a row
with null component_id and is not linked. An empty table gives no rows. Only doc_id and text are read, so
other columns cannot clash.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, lower_bytes, materialise, mix64, share, shingle_hashes, shuffle_partitions, table, text_slices, tidy, unmix64, word_hashes

ROW = "token long, salt int, doc long, n int, pos int"
MET = "kind int, doc long, n int, lead long, near boolean, token long, salt int, pos int"
#: pos of rows that are not postings.
COPY, SET = -1, -2
#: salt of a shingle that is not hot.
WHOLE = -1


@dataclass(frozen=True)
class Join:
    """words in a shingle; link at percent % similarity or more; number of orders; log2 of the sketch's counters at most; prefix rows that a receiving task is meant for, and tasks at most; prefix rows of a shingle under one salt, about; documents compared with one copy of a leader; documents on a side of a grid's cell; log2 of the bit table that spares texts outside all pairs the journey."""

    words: int = 5
    percent: int = 75
    orders: int = 3
    most_bits: int = 25
    task_rows: int = 1_500_000
    most_tasks: int = 50_000
    hot_rows: int = 2048
    partners: int = 256
    cell: int = 8192
    mark_bits: int = 24

    def prefix(self, n: int) -> int:
        return n - (self.percent * n + 99) // 100 + 1

    def most(self, n, pos):
        """The longest partner of a document of n shingles under the shingle at pos."""
        return (100 + self.percent) * (n - pos) // self.percent - n


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(word_hashes(lower_bytes(text)), words))


def order_keys(tokens: np.ndarray, bands: np.ndarray, order: int) -> np.ndarray:
    """Sort keys of shingles in one of the global orders: the band of commonness, then a seeded hash."""
    seeded = mix64(tokens ^ np.uint64(order * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return bands[(tokens >> np.uint64(65 - len(bands).bit_length())).astype(np.int64)].astype(np.uint64) << np.uint64(58) | seeded >> np.uint64(6)


def prefix_of(tokens: np.ndarray, bands: np.ndarray, order: int, join: Join) -> np.ndarray:
    """The prefix of a set in one order, first shingle first."""
    keys = order_keys(tokens, bands, order)
    k = join.prefix(len(tokens))
    if k < len(tokens):
        least = np.argpartition(keys, k - 1)[:k]
        return tokens[least[np.argsort(keys[least])]]
    return tokens[np.argsort(keys)]


def _sketch(docs: DataFrame, join: Join) -> tuple[np.ndarray, int, float]:
    """(band of each counter, number of shingles, shingles a counter). Shingles are counted by their leading `most_bits` bits; with the total known, counters are added together until one holds about four shingles of no importance."""
    bits, parts = join.most_bits, 1 << 9
    width = (1 << bits) // parts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(held: list) -> tuple[np.ndarray, np.ndarray]:
            at, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(at, kind="stable")
            at, n = at[order], n[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            return at[first], np.add.reduceat(n, first)

        def out(held: list) -> pa.RecordBatch:
            at, n = merged(held)
            edges = np.searchsorted(at, np.arange(parts + 1, dtype=np.int64) * width)
            some = np.flatnonzero(edges[1:] > edges[:-1])
            blobs = [zlib.compress((at[edges[k] : edges[k + 1]] - np.uint32(k * width)).astype("<u4").tobytes() + n[edges[k] : edges[k + 1]].astype("<u4").tobytes(), 1) for k in some]
            return pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()), "counts": pa.array(blobs, pa.binary())})

        held, rows = [], 0
        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                found = [shingle_hashes(word_hashes(lower_bytes(t)), join.words) for t in texts]
                at, n = np.unique((np.concatenate(found) >> np.uint64(64 - bits)).astype(np.uint32), return_counts=True)
                if len(at):
                    held.append((at, n))
                    rows += len(at)
            if rows > 3_000_000:
                yield out(held)
                held, rows = [], 0
        if held:
            yield out(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(zlib.decompress(blob), dtype="<u4")
                at, n = data[: len(data) // 2], data[len(data) // 2 :]
                if k not in sums:
                    sums[k] = np.zeros(width, dtype=np.int64)
                sums[k][at] += n
        if sums:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "total": pa.array([int(c.sum()) for c in sums.values()], pa.int64()), "counts": pa.array([zlib.compress(c.tobytes(), 1) for c in sums.values()], pa.binary())})

    spread = docs.select("text").mapInArrow(tidy(count), "part int, counts binary")
    summed = materialise(spread.repartition(shuffle_partitions(docs.sparkSession), "part").mapInArrow(tidy(add), "part int, total long, counts binary"), "counts")
    total = summed.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    kept = min(bits, max(9, (total // 4).bit_length()))
    mean = total / (1 << kept)

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for blob in batch.column(1).to_pylist():
                c = np.frombuffer(zlib.decompress(blob), dtype=np.int64).reshape(-1, 1 << (bits - kept)).sum(axis=1)
                excess = (c - mean) / np.sqrt(mean + 1) / 4
                blobs.append(zlib.compress(np.where(excess < 1, 0, 1 + np.floor(np.log2(np.maximum(excess, 1)))).clip(0, 31).astype(np.uint8).tobytes(), 1))
            yield pa.RecordBatch.from_pydict({"part": batch.column(0), "bands": pa.array(blobs, pa.binary())})

    bands = np.zeros((parts, (1 << kept) // parts), dtype=np.uint8)
    for row in summed.select("part", "counts").mapInArrow(band, "part int, bands binary").collect():  # 2^most_bits bytes at most
        bands[row["part"]] = np.frombuffer(zlib.decompress(row["bands"]), dtype=np.uint8)
    return bands.reshape(-1), int(total), mean


def _band(tokens: np.ndarray, bands: np.ndarray) -> np.ndarray:
    return bands[(tokens >> np.uint64(65 - len(bands).bit_length())).astype(np.int64)]


def _postings(docs: DataFrame, bands, mean: float, join: Join) -> DataFrame:
    """Of each row of docs a row (COPY or SET); of each distinct set of a batch its prefix in the first order."""
    usual = 1 + max(0, int(np.log2(join.hot_rows / (4 * np.sqrt(mean + 1)) + 1)))  # the last band whose shingles are not hot

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int, int], int] = {}  # of this batch: set -> its first document
        for batch in batches:
            ids = batch.column(0).to_numpy()
            seen.clear()
            for a, texts in text_slices(batch.column(1)):
                token, salt, doc, n, pos = [], [], [], [], []

                def put(tokens, salts, first, size, places, to=(token, salt, doc, n, pos)):
                    for column, values in zip(to, (tokens, salts, np.full(len(tokens), first), np.full(len(tokens), size), places), strict=True):
                        column.append(values)

                for k, text in enumerate(texts, a):
                    s = shingle_set(text, join.words)
                    mark = (len(s), int(s.sum()), int((s >> np.uint64(7) ^ mix64(s)).sum())) if len(s) else None
                    first = seen.setdefault(mark, int(ids[k])) if mark else int(ids[k])
                    own = mix64(np.array([ids[k]], dtype=np.int64).view(np.uint64))
                    if not mark or first != ids[k]:
                        put(own, [WHOLE], first, len(s), [COPY])
                        continue
                    put(np.array([mark[1]], dtype=np.uint64), [WHOLE], first, len(s), [SET - (mark[2] & 0x3FFFFFFF)])
                    p = prefix_of(s, bands.value, 1, join)
                    bits = np.maximum(_band(p, bands.value).astype(np.int64) - usual, 0)
                    salts = np.where(bits > 0, (own.astype(np.int64) & 0x3FFFFFFF) & ((1 << bits) - 1), WHOLE)
                    put(p, salts, first, len(s), np.arange(len(p)))
                kinds = (np.uint64, np.int32, np.int64, np.int32, np.int32)
                whole = [np.concatenate(c).astype(t) for c, t in zip((token, salt, doc, n, pos), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(whole[0].view(np.int64)), *map(pa.array, whole[1:])], names=["token", "salt", "doc", "n", "pos"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(tidy(send), ROW)


def _meet(join: Join):
    """Of sorted rows: a row for each document, and the postings of shingles (or salts of hot ones) under which documents may link, each with its leader."""

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind, doc, n, lead, near, token, salt, pos):
            if len(doc):
                i32 = lambda x: pa.array(np.broadcast_to(x, len(doc)).astype(np.int32))
                arrays = [i32(kind), pa.array(doc), i32(n), pa.array(lead), pa.array(np.broadcast_to(near, len(doc)), pa.bool_()), pa.array(token), i32(salt), i32(pos)]
                yield pa.RecordBatch.from_arrays(arrays, names=["kind", "doc", "n", "lead", "near", "token", "salt", "pos"])

        kept, told = None, False  # rows of a group that may go on (its leader, or two at most); whether the leader was sent on
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                x = kept
            else:
                x = [batch.column(k).to_numpy() for k in range(5)]
                copy = x[4] == COPY
                if copy.any():
                    own = unmix64(x[0][copy].view(np.uint64)).view(np.int64)
                    yield from out(0, own, x[3][copy], x[2][copy], False, x[0][copy], WHOLE, COPY)
                    x = [c[~copy] for c in x]
                x = [np.concatenate(c) for c in zip(kept, x, strict=True)] if kept else x
            if not x or not len(x[0]):
                continue
            token, salt, doc, n, pos = x
            group, width = np.minimum(pos, 0), np.where(pos < 0, n, 0)
            fresh = np.ones(len(token), dtype=bool)
            fresh[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]) | (group[1:] != group[:-1]) | (width[1:] != width[:-1])
            starts = np.flatnonzero(fresh)
            size = np.diff(np.append(starts, len(token)))
            lead = np.repeat(starts, size)
            most = join.most(n.astype(np.int64), np.maximum(pos, 0))
            near = (n <= most[lead]) & (n[lead] <= most) & ~fresh
            always = (group[starts] < 0) | (salt[starts] != WHOLE)
            wide = most[starts] >= n[starts]  # the leader is the widest of a shingle's documents
            alive = always | wide & ((size > 2) | (np.add.reduceat(near, starts) > 0))
            alive[0] |= told
            show = np.repeat(alive, size)
            show[0] &= not told
            if batch is not None:
                s = starts[-1]
                decided = always[-1] or (told and s == 0) or (wide[-1] and size[-1] > 2)
                if not decided:
                    show[s:] = False
                kept = [c[s : s + 1] if decided or not wide[-1] else c[s:] for c in x]
                told = bool(decided)
            for kind, mask in ((0, show & (group < 0)), (1, show & (group == 0))):
                at = np.flatnonzero(mask)
                yield from out(kind, doc[at], n[at], doc[lead[at]], near[at], token[at], salt[at], pos[at])

    return receive


def _most(join: Join, n: str = "n", pos: str = "pos"):
    return (F.floor((100 + join.percent) * (F.col(n) - F.col(pos)) / F.lit(join.percent)) - F.col(n)).cast("int")


def _marks(pairs: DataFrame, join: Join) -> np.ndarray:
    """A bit table of fixed size in which every document of pairs has its bit set."""
    size, part = 1 << join.mark_bits, 1 << 15

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy()
            order = np.unique(at)
            for k in np.unique(order // part).tolist():
                mine = order[order // part == k] - k * part
                parts.setdefault(k, np.zeros(part, dtype=bool))[mine] = True
        if parts:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(parts), pa.int64()), "bits": pa.array([zlib.compress(np.packbits(b).tobytes(), 1) for b in parts.values()], pa.binary())})

    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    dealt = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(size)).alias("place")).distinct().repartition(shuffle_partitions(pairs.sparkSession), F.floor(F.col("place") / part))
    table = np.zeros(size, dtype=bool)
    for row in dealt.mapInArrow(fold, "part long, bits binary").collect():  # 2^mark_bits bits at most
        table[row["part"] * part : (row["part"] + 1) * part] |= np.unpackbits(np.frombuffer(zlib.decompress(row["bits"]), dtype=np.uint8)).astype(bool)
    return np.packbits(table)


def _compared(pairs: DataFrame, made: DataFrame, parse: Callable, agree: Callable, join: Join) -> DataFrame:
    """Those of pairs(a, b) for which agree(parse(data of a), parse(data of b)) holds; made has (doc, data). One copy of a's data goes to each `partners` of its pairs."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left = None, []
        for batch in batches:
            a, salt, b = (batch.column(k).to_pylist() for k in range(3))
            keep = []
            for k in range(len(a)):
                if at != (a[k], salt[k]):
                    at, left = (a[k], salt[k]), []
                x = parse(batch.column(3)[k].as_py())
                if b[k] is None:
                    left.append(x)
                elif any(agree(y, x) for y in left):
                    keep.append(k)
            yield pa.RecordBatch.from_pydict({"a": pa.array([a[k] for k in keep], pa.int64()), "b": pa.array([b[k] for k in keep], pa.int64())})

    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(join.partners)).cast("int").alias("salts"))
    salted = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
    members = salted.select(F.col("b").alias("doc"), "a", "salt", F.col("b"))
    leaders = sizes.select(F.col("a").alias("doc"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"))
    dealt = members.union(leaders).join(made, "doc").select("a", "salt", "b", "data")  # one join, so that the data are dealt by document once
    dealt = dealt.repartition(shuffle_partitions(pairs.sparkSession), "a", "salt")
    return dealt.sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(tidy(test), "a long, b long").distinct()


def _verified(docs: DataFrame, pairs: DataFrame, bands, join: Join) -> DataFrame:
    """Those of pairs(a, b) that link: first by the prefixes of the other orders, then by the texts. Only documents in a pair travel (a bit table of fixed size tells most of them), texts compressed."""
    marks = share(docs.sparkSession, _marks(pairs, join))

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            place = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((marks.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)))
            for a, texts in text_slices(batch.column(1)):
                rows = list(dict.fromkeys(zip(batch.column(0).slice(a, len(texts)).to_pylist(), map(lower_bytes, texts), strict=True)))
                signs = []
                for _, t in rows:
                    s = np.unique(shingle_hashes(word_hashes(t), join.words))
                    orders = [np.unique((mix64(prefix_of(s, bands.value, o, join)) >> np.uint64(32)).astype("<u4")) for o in range(2, join.orders + 1)] if len(s) else []
                    signs.append(np.concatenate([np.array([len(o) for o in orders], dtype="<u4"), *orders]).astype("<u4").tobytes())
                yield pa.RecordBatch.from_pydict({"doc": pa.array([i for i, _ in rows], pa.int64()), "signs": pa.array(signs, pa.binary()), "text": pa.array([zip_.compress(t) for _, t in rows], pa.binary())})

    def prefixes(data: bytes) -> list[np.ndarray]:
        x = np.frombuffer(data, dtype="<u4")
        cuts = np.cumsum(np.r_[join.orders - 1, x[: join.orders - 1].astype(np.int64)]) if len(x) else [0]
        return [x[a:b] for a, b in itertools.pairwise(cuts)]

    def meet(x: np.ndarray, y: np.ndarray) -> bool:
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        return bool((y[at] == x).any())

    def shingles(data: bytes) -> np.ndarray:
        import zstandard

        return np.unique(shingle_hashes(word_hashes(zstandard.ZstdDecompressor().decompress(data)), join.words))

    def link(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both > 0 and 100 * both >= join.percent * (len(x) + len(y) - both)

    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << join.mark_bits)).alias("place")
    made = materialise(docs.where("doc_id is not null and text is not null").select("doc_id", "text", place).mapInArrow(tidy(press), "doc long, signs binary, text binary"), "texts")
    if not made.groupBy("doc").count().where("count > 1").isEmpty():  # repeated ids: equal texts of one count once
        made = materialise(made.dropDuplicates(["doc", "text"]), "texts")
    if join.orders > 1:
        pairs = _compared(pairs, made.select("doc", F.col("signs").alias("data")), prefixes, lambda x, y: bool(x) and all(map(meet, x, y)), join)
        pairs = materialise(pairs, "candidates")
    return _compared(pairs, made.select("doc", F.col("text").alias("data")), shingles, link, join)


def _between(posts: DataFrame, first: DataFrame, join: Join) -> DataFrame:
    """(a, b, a's component, b's component) of documents in different components that a shingle lets link."""
    named = posts.join(first, posts["doc"] == first["node"], "left")
    named = materialise(named.select("token", "doc", "n", _most(join).alias("most"), F.coalesce("component", "doc").alias("component")), "named")
    wide = F.min(F.when(F.col("most") >= F.col("n"), F.col("n")))
    parts = named.groupBy("token", "component").agg(F.count("*").alias("rows"), wide.alias("wide"))
    split = parts.groupBy("token").agg(
        F.max_by("component", F.struct("rows", "component")).alias("largest"), F.count("*").alias("parts"), F.sum("rows").alias("all"), F.max("rows").alias("many"), F.min("wide").alias("wide")
    )
    cells = lambda rows: F.ceil(rows / F.lit(join.cell)).cast("int")
    split = split.where("parts > 1 and wide is not null").select("token", "largest", "wide", cells(F.col("all")).alias("many"), cells(F.col("all") - F.col("many")).alias("few"))
    rest = named.join(split, "token").where("most >= wide")  # the shorter of a pair is wide, so no other row can be in one
    step = F.log(F.lit(110.0 / join.percent))  # lengths of a pair lie in the same class or in neighbours
    rest = materialise(rest.withColumn("size", F.floor(F.log(F.col("n")) / step).cast("int")), "rest")
    turn = lambda cells: F.pmod(F.xxhash64("doc"), F.col(cells)).cast("int")
    every = lambda cells: F.explode(F.sequence(F.lit(0), F.col(cells) - 1))
    many = rest.select("token", "doc", "n", "most", "component", "size", turn("many").alias("row"), every("few").alias("column"))
    few = rest.where("component <> largest").select("token", *(F.col(c).alias("f_" + c) for c in ("doc", "n", "most", "component")), F.explode(F.sequence(F.col("size") - 1, F.col("size") + 1)).alias("size"), turn("few").alias("column"), "many")
    few = few.select("*", every("many").alias("row")).drop("many")
    near = few.join(many, ["token", "size", "row", "column"]).where("component <> f_component and n <= f_most and f_n <= most")
    swap = F.col("doc") < F.col("f_doc")
    pick = lambda x, y: F.when(swap, F.col(x)).otherwise(F.col(y))
    return near.select(pick("doc", "f_doc").alias("a"), pick("f_doc", "doc").alias("b"), pick("component", "f_component").alias("a_component"), pick("f_component", "component").alias("b_component")).distinct()


def components(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """(doc_id, n_shingles, component_id): a row for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts, total, mean = _sketch(docs, join)
    bands = share(spark, counts)
    tasks = max(shuffle_partitions(spark), min(join.most_tasks, -(-total * (100 - join.percent) // 100 // join.task_rows)))
    dealt = _postings(docs, bands, mean, join).repartition(tasks, "token", "salt")
    dealt = dealt.sortWithinPartitions("token", "salt", F.least("pos", F.lit(0)), F.when(F.col("pos") < 0, F.col("n")).otherwise(0), F.col("pos") / F.col("n"), "doc")
    met = materialise(dealt.mapInArrow(tidy(_meet(join)), MET), "met")

    members = met.where("kind = 0").select("doc", "n", "lead")
    posts = met.where("kind = 1").select("token", "salt", "doc", "n", "pos", "lead", "near")
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    star = posts.where("near and doc <> lead").select(*pair("doc", "lead"))
    leads = posts.where(f"salt <> {WHOLE} and doc = lead").select("token", "doc", "n", _most(join).alias("most"), (F.col("pos") / F.col("n")).alias("place"))
    best = leads.groupBy("token").agg(F.min_by(F.struct("doc", "n", "most"), F.struct("place", "doc")).alias("best"))
    tops = leads.join(best, "token").where("doc <> best.doc and n <= best.most and best.n <= most").select(*pair("doc", "best.doc"))
    star = materialise(star.union(tops).distinct(), "star")
    links = materialise(_verified(docs, star, bands, join), "links")
    # Equal sets hang on their representatives: of a task, then of all tasks.
    same = members.where("doc <> lead").select(F.col("doc").alias("a"), F.col("lead").alias("b"))
    first = connected_components(links.union(same))

    near = materialise(_between(posts, first, join).join(star, ["a", "b"], "left_anti"), "near")
    shown = members.join(first, members["doc"] == first["node"], "left").select("doc", "n", F.coalesce("component", "doc").alias("component_id"))
    if not near.isEmpty():
        joined = near.join(_verified(docs, near.select("a", "b"), bands, join), ["a", "b"])
        moved = connected_components(joined.select(F.col("a_component").alias("a"), F.col("b_component").alias("b")))
        moved = moved.withColumnRenamed("component", "now")
        shown = shown.join(moved, shown["component_id"] == moved["node"], "left").select("doc", "n", F.coalesce("now", "component_id").alias("component_id"))
    shown = shown.select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id")

    def sizes_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(shingle_set(t, join.words)) for _, texts in text_slices(batch.column(0)) for t in texts]
            yield pa.RecordBatch.from_pydict({"n_shingles": pa.array(n, pa.int64())})

    nameless = docs.where("doc_id is null").select("text").mapInArrow(sizes_only, "n_shingles long")
    return shown.unionByName(nameless.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id")))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
